"""Part of variantloom; see README.md."""
