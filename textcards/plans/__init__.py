"""textcards.plans"""
