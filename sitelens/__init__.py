"""Bulk web-page metadata, URL hygiene and access-log analytics on PySpark."""
