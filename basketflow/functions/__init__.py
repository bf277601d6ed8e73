"""Column-expression helpers: JSON extraction, normalisation, predicates, PII.

Everything here returns ``pyspark.sql.Column`` objects built from built-in
functions only, so every expression stays inside whole-stage codegen.
"""
