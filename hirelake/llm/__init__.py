"""Operators of a training-data pipeline over documents and pages.

Each operator reads only the columns it names, so further columns of any name do no harm.
"""
