"""Operators of a training-data pipeline: de-duplication, language ID, BPE, WARC.

The subpackage stands alone: nothing outside it imports it, and removing the
folder leaves the rest of the library intact.
"""
