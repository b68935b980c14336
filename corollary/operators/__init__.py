"""Verification, mining, compression, recovery and tuning."""
