"""Column expressions and small checked frames that the operators build on."""
