"""siltgrid.operators"""
