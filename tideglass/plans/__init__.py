"""tideglass.plans"""
