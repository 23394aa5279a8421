"""Operators over keyed logs; each takes and returns DataFrames."""
