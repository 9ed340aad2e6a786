"""Readers and writers and the HTML page extraction job."""
