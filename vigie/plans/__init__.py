"""Composed operators (I1-I16), jobs and the registered queries."""
