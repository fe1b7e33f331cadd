"""siltgrid.functions"""
