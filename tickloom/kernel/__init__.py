"""Order-dependent state machines: plain Python without Spark, and in ``spark`` their grouped runners."""
