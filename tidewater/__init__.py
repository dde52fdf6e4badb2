"""Tidewater: vessel-tracking and corpus analytics expressed as Spark plans."""
