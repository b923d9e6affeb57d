"""Where rows come from and where results go: table specs, readers, writers."""
