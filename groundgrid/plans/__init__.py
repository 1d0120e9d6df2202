"""groundgrid.plans"""
