"""Analytics over e-commerce and user-behaviour data as Spark jobs."""
