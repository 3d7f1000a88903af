"""tideglass.functions"""
