"""Training-data operators: ten corpus steps that scale with the number of executors.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
