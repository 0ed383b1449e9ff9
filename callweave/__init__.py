"""callweave: analytics over transcribed phone conversations, as Spark jobs.

Layers, from the bottom up:

``functions``  column expressions, predicates, the rule compiler and its rule data
``sources``    readers and sinks
``operators``  one DataFrame-in, DataFrame-out function per data operator
``plans``      the composed chains a user normally calls
"""
