"""Sources: repositories, manifests, journals, and views over plain tables."""
