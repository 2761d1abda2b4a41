"""Functions of the engine, written as DataFrame expressions."""
