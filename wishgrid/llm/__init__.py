"""Operators for preparing training text, their queries and SQL counterparts; nothing else imports this package."""
