"""Building blocks as Spark SQL expressions; all of them run inside the JVM.

Every function takes SQL text and gives SQL text, or takes Columns and gives a
Column.  Expressions are put together as text because a large one then reaches
the JVM in one call, which keeps planning fast.
"""
