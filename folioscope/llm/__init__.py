"""Operators of a training-data pipeline. ``folioscope.llm.queries`` registers them; nothing else imports this package."""
