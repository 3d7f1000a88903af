"""tideglass.streaming"""
