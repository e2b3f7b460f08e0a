"""Where bars come from and results go to."""
