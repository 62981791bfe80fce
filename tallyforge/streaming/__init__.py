"""Continuous maintenance of states."""
