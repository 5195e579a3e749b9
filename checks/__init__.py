"""Registered queries and the DuckDB SQL each is compared with."""
