"""Registered queries over the shared tables, each with its SQL check where SQL can state it."""
