"""Planning helpers: grids, tiles, materialised stages, distributed running sums."""
