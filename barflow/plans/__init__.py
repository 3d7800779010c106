"""Registered queries over the warehouse tables, each with its SQL check where SQL can say it."""
