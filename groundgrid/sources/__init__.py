"""groundgrid.sources"""
