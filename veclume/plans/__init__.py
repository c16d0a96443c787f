"""Plans that choose between physical strategies."""
