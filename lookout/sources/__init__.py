"""lookout.sources"""
