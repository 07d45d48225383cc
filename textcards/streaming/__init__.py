"""textcards.streaming"""
