"""dendrovox.functions"""
