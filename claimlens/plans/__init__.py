"""Session setup, the all-signals flag table and the provider report."""
