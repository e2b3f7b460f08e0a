"""Column functions: windows, protected arithmetic, repeatable randomness."""
