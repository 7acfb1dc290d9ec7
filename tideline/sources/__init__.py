"""Readers, and adapters from the driver's tables to the canonical model."""
