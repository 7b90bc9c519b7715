"""The whole cleaning run and the catalogue of checked queries."""
