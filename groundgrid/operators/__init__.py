"""groundgrid.operators"""
