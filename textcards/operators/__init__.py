"""textcards.operators"""
