"""Approximate analytics over keyed event tables and streams, as PySpark DataFrame operators."""
