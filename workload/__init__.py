"""The driver's queries: test tables bound to the library's inputs, with check SQL."""
