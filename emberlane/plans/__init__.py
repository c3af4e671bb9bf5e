"""Query plans. Importing registry and the modules below fills its tables."""
