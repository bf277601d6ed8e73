"""Composed jobs: tables resolved from a data folder, query catalog, ETL."""
