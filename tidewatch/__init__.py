"""Recurrent-event risk tables, alert budgets and their audits on Spark."""
