"""lookout.streaming"""
