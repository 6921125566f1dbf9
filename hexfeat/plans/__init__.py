"""Ready-made queries over the star-schema fixtures, with their SQL oracles."""
