
"""The catalog is filled by importing its modules."""
