"""siltgrid.sources"""
