"""Scalar functions: the TRS algebra as native expressions, the text grammar as Arrow functions."""
