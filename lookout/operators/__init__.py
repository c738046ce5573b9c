"""lookout.operators"""
