"""dendrovox.operators"""
