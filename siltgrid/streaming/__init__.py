"""siltgrid.streaming"""
