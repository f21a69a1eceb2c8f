"""Sources: canonical tables of multi-view tracking, and readers and writers for them."""
