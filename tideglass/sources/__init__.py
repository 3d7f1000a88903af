"""tideglass.sources"""
