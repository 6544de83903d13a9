"""Schema changes, migrations and generated records."""
