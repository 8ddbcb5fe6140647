"""Which way a fit is computed."""
