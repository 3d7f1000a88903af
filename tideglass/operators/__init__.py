"""tideglass.operators"""
