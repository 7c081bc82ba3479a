"""Operators: DataFrame to DataFrame. Time is passed in; every order has an explicit column."""
