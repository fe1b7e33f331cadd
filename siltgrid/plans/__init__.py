"""siltgrid.plans"""
