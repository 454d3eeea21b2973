"""DataFrame to DataFrame jobs; every key includes the company."""
