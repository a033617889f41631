"""dendrovox.plans"""
