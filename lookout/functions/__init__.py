"""lookout.functions"""
