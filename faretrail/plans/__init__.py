"""Reports over operator outputs and the registered query catalog."""
