"""Order checks, cleaning, reports and run audit as plain DataFrame functions."""
