"""lookout.plans"""
