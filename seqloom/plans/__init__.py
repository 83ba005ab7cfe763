"""Plan inspection and measured comparisons of physical strategies."""
