"""Scalar functions as Column builders; none of them needs Python on the executors."""
