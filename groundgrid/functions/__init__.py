"""groundgrid.functions"""
