"""Column builders: everything here returns a Column or a list of names, never runs a job."""
