"""Numpy kernels for one ring at a time; every result carries an error word instead of raising."""
