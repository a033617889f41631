"""dendrovox.sources"""
