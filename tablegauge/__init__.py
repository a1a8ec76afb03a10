"""Profiles tables, keeps their statistics over time and audits them, as Spark jobs."""
