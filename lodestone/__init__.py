"""lodestone"""
