"""textcards.sources"""
