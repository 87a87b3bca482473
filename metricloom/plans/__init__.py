"""Rules, their validation, and how they become groupings: what is decided on the driver before a query runs."""
