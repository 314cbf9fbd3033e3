"""Readers with declared schemas, generators and writers."""
