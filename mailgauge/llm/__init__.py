"""Training-data operators: each module holds one operator; ``queries`` lists their thin queries."""
