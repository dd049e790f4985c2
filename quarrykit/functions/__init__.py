"""Native column functions and the fixed values that they depend on."""
